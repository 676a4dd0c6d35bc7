"""Where records live: snapshot tables with an atomically published version."""
