"""Runnable jobs on the library; each has a command line and a config file of its name."""
