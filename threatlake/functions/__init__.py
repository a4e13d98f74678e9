"""threatlake.functions"""
