"""The named analyses: functions from :class:`~lodgelens.tables.HotelTables` to DataFrames."""
