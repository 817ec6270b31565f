"""linehaul: timetable network analytics and corpus preparation on Spark DataFrames."""
