"""hearthline.operators"""
