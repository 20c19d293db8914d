"""Multi-operator jobs, derived input views and the registered queries."""
