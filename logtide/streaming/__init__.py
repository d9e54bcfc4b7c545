"""The window counts over a growing folder of logs."""
