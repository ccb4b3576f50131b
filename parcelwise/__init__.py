"""Return-request triage as Spark DataFrame operators.

Every operator takes DataFrames and returns a lazy DataFrame over whole tables;
a single case is a filter on the same plan.
"""
