"""What is to be computed: types, values, schemas, filters and their JSON form."""
