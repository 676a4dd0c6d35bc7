"""What a scan or a schema is before Spark sees it: tokens, errors, schemas, descriptors."""
