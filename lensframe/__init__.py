"""lensframe: reconstruction analytics as DataFrame -> DataFrame operators."""
