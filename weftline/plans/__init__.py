"""End-to-end plans: strategy choice, file to file jobs, the registered queries."""
