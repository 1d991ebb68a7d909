"""hearthline.streaming"""
