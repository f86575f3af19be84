"""Set-oriented operators over shape, element, pixel, review and event tables."""
