"""chunkloom.streaming"""
