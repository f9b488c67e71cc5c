"""loomwright.plans"""
