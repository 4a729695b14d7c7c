"""Where documents come from: tables and file trees."""
