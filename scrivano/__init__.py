"""Semi-structured document analytics as DataFrame operators."""
