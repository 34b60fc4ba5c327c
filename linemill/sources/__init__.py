"""Where lines come from and go to."""
