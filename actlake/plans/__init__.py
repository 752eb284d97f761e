"""Jobs composed of operators: parsing pages, importing versions, views, hand-off to labelling."""
