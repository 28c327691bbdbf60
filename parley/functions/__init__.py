"""parley.functions"""
