"""hearthline.functions"""
