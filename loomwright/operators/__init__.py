"""loomwright.operators"""
