"""filmloom.functions"""
