"""threatlake.streaming"""
