"""loomwright.functions"""
