"""From analyzed plans to column origins."""
