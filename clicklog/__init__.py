"""Click-log analytics on PySpark: session logs, click models, metrics, synthetic clicks and reports."""
