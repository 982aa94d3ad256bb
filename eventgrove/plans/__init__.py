"""Multi-step plans: frozen tables, distributed ordering and the salience query."""
