"""tessera sources"""
