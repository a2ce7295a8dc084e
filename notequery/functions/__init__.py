"""Column expressions over notes and text."""
