"""Sources and sinks: file trees, tables, reports."""
