"""Sources and sinks: table scans, log/CSV readers, and the test-table adapters."""
