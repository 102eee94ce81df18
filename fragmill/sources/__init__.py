"""Sources and sinks: adapters from tables, files, traces and the index directory."""
