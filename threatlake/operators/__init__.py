"""threatlake.operators"""
