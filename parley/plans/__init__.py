"""parley.plans"""
