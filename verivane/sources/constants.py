"""Dates of the derived series."""

TODAY = "2001-08-02"
OPEN_FROM = "2001-07-28"  #: forecasts from this day on are pending
SHIFT = 8766  #: days from shipping dates to the events' year
AS_OF = "1999-03-15 12:00:00"  #: a moment for as-of reads
