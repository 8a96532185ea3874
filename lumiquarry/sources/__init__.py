"""Reading media folders, side files and libraries."""
