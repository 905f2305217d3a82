"""Reading landed payloads, pages and documents; writing tables and exports."""
