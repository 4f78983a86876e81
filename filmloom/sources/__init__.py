"""filmloom.sources"""
