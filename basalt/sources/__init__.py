"""Where logs come from: tables, files, text dumps."""
