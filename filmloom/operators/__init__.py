"""filmloom.operators"""
