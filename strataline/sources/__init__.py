"""Where rows come from and go to: logs, files, stores."""
