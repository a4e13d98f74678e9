"""threatlake.sources"""
