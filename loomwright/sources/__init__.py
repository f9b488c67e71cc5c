"""loomwright.sources"""
