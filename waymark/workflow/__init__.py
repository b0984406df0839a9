"""A contract-checked laboratory workflow: state machine, planner and the Spark operators over simulated cases."""
