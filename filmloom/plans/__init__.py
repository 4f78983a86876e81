"""filmloom.plans"""
