"""Detection, classification, scanning and masking operators over DataFrames."""
