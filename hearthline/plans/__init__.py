"""hearthline.plans"""
