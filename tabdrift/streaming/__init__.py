"""Versions that arrive as a stream. The batch diffs know no late data or windows, and neither does this."""
