"""Part of sieveloom."""
