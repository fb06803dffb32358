"""treeline: exact Euclidean minimum spanning trees and corpus operators on Spark DataFrames."""
