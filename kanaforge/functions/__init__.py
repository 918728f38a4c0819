"""Column functions and kana engines."""
