"""tessera operators"""
