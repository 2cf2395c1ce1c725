"""Part of the taxolith engine."""
