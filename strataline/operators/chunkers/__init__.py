"""Source-code chunkers, one file to many chunks."""
