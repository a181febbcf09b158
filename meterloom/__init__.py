"""Usage analytics for metered API accounts, expressed as Spark DataFrame jobs.

Every public function takes DataFrames (plus explicit times) and returns a DataFrame covering all
workspaces at once; nothing here collects rows to the driver or loops over workspaces.
"""
