"""Operations of training-data pipelines over tables of documents and vectors."""
