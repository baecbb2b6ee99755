"""From one table to a report: plan, packs, charts, insights, text."""
