"""Sources and sinks: analysis records, texts as lines, logs, coverage reports, pages."""
