"""Event-timeline analytics on PySpark: signals to events, events to engagements, matching, scoring and KPIs."""
