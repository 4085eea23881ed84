"""cairn.operators"""
