"""DataFrame-to-DataFrame operators; none of them collects rows to the driver."""
