"""sieveworks: corpus scanning, rule evaluation and finding analytics as Spark plans."""
