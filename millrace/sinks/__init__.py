"""millrace.sinks"""
