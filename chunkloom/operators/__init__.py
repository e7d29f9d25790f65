"""chunkloom.operators"""
