"""hearthline.sources"""
