"""chunkloom.functions"""
