"""Where graphs and features come from and go to."""
