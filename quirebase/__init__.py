"""quirebase: document-layout and corpus analytics on Spark DataFrames."""
