"""keyfold.functions"""
