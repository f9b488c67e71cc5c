"""loomwright.streaming"""
