"""The layered student table and the report jobs."""
