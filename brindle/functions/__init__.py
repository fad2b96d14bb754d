"""Column functions: nothing here runs a job."""
