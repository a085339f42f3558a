"""Writers of route files and pages."""
