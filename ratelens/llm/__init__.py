"""Operations of a training-data pipeline (dedup, decontamination, classifiers, mixing, output)."""
