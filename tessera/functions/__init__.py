"""tessera functions"""
