"""tessera streaming"""
