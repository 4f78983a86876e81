"""filmloom.streaming"""
