"""The batch operators as continuously fed jobs."""
