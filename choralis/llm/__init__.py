"""Operators for training text: detection, repair, linking and encoding at corpus scale."""
