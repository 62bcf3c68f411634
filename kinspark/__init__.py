"""Household reconstruction and kinship lineage on Spark DataFrames."""
