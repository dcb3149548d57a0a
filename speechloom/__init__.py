"""Speech-corpus analytics as Spark jobs.

Every public function takes and returns DataFrames (or builds Column
expressions), keeps no state and creates no session.
"""
